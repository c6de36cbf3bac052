"""strandlog.operators"""
