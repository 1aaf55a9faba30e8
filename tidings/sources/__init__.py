"""Reading article files, tagged lines, exports and replays; writing results."""
