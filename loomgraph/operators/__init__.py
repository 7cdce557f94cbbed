"""operators of loomgraph."""
