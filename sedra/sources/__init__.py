"""Sources: files in a folder, and the tables of a data set."""
