"""Tables, files, archives and ledgers as DataFrames."""
