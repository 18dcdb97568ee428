"""Texts that every operator must stand."""

# Nulls, empty and blank texts, ties, repeats, and a long text.
ODD = [None, "", "   ", "\n\t", "a", "one two", "one two", "MIT License, CC BY x", "x" * 3000,
       "word " * 4000, "émigré naïve 漢字 🙂 test", "+1 (743) 555-3824 a.b@c.org 10.0.0.1"]
