"""PageQuarry: retrieval, tables, finance, memory and verification over business documents, as Spark DataFrames."""
