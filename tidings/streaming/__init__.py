"""Topics kept up to date over a stream of documents."""
