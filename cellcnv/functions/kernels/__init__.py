"""Small vectorised numpy kernels that grouped maps call."""
