"""revcast.functions"""
