"""Two levels of topics over large text collections and text streams."""
