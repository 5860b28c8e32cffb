"""Models: making, comparing, tuning, calibrating and explaining them."""
