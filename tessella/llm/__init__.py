"""Operators for building training data: each module holds one problem's operator."""
