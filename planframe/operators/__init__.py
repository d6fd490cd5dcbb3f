"""The steps of a plan, each a function from a sheet to a sheet."""
