"""Making matrices and vectors from arrays, tables and files, and giving them out again."""
