"""baseloom.plans"""
