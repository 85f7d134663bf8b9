SF = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"
