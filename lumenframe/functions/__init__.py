"""lumenframe.functions"""
