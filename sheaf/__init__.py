"""sheaf: a document-intelligence engine whose operators are DataFrame transformations."""
