"""operators of reelrank."""
