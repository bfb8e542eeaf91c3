"""lorewright.functions"""
