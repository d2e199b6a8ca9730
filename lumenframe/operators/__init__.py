"""lumenframe.operators"""
