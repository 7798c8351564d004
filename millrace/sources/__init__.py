"""Sources: textual logs, binary logs, derived operation logs."""
