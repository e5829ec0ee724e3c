"""Training-data operators: thirteen dealt methods, their registered queries and the corpus stages built from them."""
