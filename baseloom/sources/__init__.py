"""baseloom.sources"""
