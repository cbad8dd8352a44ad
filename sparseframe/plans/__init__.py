"""What is known of a matrix beside its entries, and how that steers plans."""
