from orderlens.operators import aggregate, cleaning, partials, quality, relational, sketches

__all__ = ["aggregate", "cleaning", "partials", "quality", "relational", "sketches"]
