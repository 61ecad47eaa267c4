"""DataFrame operators; every one takes and returns DataFrames and runs no action of its own."""
