"""Reading and writing tables, files and exports."""
