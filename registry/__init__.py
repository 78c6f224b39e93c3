"""The registered queries: the package's operators over the supplied tables, and their SQL twins."""
