"""Relational operators: each takes and returns DataFrames and triggers no action unless its docstring says so."""
