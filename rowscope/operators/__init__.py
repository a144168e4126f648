"""Operators over sources: profile, schema, diff, visual model, code generation, export and edits."""
