"""revcast.operators"""
