"""Connected components, as in the library's operators."""

from millrace.operators.components import connected_components  # noqa: F401  (re-exported)
