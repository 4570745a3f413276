"""Lexer, parser, AST and lowering of the mini SQL."""
