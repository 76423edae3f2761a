"""Query languages, the builder and the compiler to DataFrames."""
