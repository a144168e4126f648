"""Kinds, number texts and accessors: the scalar layer under the operators."""
