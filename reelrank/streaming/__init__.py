"""streaming of reelrank."""
