"""Readers and writers for datasets, source trees and run folders."""
