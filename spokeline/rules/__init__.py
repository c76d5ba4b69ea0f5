"""A small language of decision rules that compiles to Spark column expressions."""

from spokeline.rules.compiler import apply, apply_table, matcher
from spokeline.rules.language import Program, read_matcher, read_program

__all__ = ["Program", "apply", "apply_table", "matcher", "read_matcher", "read_program"]
