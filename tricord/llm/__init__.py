"""Training-data operators: tokens, duplicates, decontamination, web pages, classifiers."""
