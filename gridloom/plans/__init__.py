"""Array handles, layouts and the engine that keeps them."""
