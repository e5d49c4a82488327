"""The job list has no streaming operator; batch jobs resume by anti-joining finished work."""
