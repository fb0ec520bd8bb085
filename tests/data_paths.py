"""Where the tests find their data."""

SF_SMALL = "/root/testdata/sf0.001"
