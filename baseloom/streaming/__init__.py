"""baseloom.streaming"""
