"""Spark jobs for long multichannel biosignal recordings and their annotations."""
