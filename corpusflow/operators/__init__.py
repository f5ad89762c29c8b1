"""corpusflow.operators"""
