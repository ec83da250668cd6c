"""Text front ends and driver-side planning; both compile to DataFrames."""
