"""Operators for preparing training corpora: each module is one operator."""
