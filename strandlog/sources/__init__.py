"""strandlog.sources"""
