"""DataFrame-to-DataFrame operators: clustering, trees, bags of words, frame queries."""
