"""sources of reelrank."""
