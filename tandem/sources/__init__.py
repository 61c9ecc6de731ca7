"""Readers and writers; nothing outside this folder touches a file system."""
