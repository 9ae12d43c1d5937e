"""User-level operators on the three tables and on the frames derived from them."""
