"""Column functions: homographies and guarded statistics, all inside Catalyst."""
