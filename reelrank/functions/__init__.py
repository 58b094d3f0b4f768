"""functions of reelrank."""
