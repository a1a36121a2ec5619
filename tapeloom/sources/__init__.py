"""Feed schemas, asset readers/writers and market-shaped views."""
