"""baseloom.functions"""
