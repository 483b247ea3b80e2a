"""The query language: parser and compiler to DataFrame expressions."""
