"""How plans are cut, salted and chained."""
