"""corpusflow.sources"""
