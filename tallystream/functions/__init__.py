"""Statistical services over units, as DataFrame plans."""
