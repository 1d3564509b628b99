"""Jobs that compose the operators end to end."""
