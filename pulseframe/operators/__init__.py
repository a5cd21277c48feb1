"""DataFrame -> DataFrame operators; every one is lazy and free of driver-side loops over data."""
