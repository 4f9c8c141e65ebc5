"""baseloom.operators"""
