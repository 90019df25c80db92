"""Operators on the texts, vectors and modules of a corpus of slides, at training-data scale."""
