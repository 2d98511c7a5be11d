"""Sources: driver tables and the bronze views over them."""
