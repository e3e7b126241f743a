"""Pages, links and the corpus store."""
