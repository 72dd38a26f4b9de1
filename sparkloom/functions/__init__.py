"""Scalar functions of the workflow expression palette, as Column builders."""
