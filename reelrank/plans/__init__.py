"""plans of reelrank."""
