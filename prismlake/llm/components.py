"""Connected components, as the text operators import them."""

from ..operators.components import components  # noqa: F401
