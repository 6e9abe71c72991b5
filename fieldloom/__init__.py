"""Declarative field programs on meshes, compiled to Spark DataFrame plans."""
