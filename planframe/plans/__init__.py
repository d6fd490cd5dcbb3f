"""Plans: typed lists of steps, checked and run on sheets."""
