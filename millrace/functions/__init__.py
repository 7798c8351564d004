"""Value functions: columns in, columns out; byte decoders for the sources."""
