"""The index as a whole: build, search, insert, save and load."""
