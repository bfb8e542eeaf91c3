"""lorewright.plans"""
