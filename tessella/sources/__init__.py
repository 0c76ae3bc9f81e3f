"""Reading and writing: catalogues, arrays, session tables, guarded and resumable results."""
