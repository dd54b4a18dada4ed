"""Readers that turn source trees and histories into DataFrames."""
