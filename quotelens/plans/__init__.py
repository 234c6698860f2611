"""The quote mart: representative quotes and everything joined to them."""
