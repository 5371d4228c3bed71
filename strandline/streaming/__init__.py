"""The recursions of strandline.operators.recursion over unbounded input."""
