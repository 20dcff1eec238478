"""Vector files, index folders, configuration files and synthetic vectors."""
