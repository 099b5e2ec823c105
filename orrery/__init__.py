"""Gradient-boosted trees and era-aware panel analytics on Spark DataFrames."""
