"""Brand operators over batch DataFrames."""
