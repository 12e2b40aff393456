"""Readers and writers of the file kinds that the engine takes in and gives out."""
