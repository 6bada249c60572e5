sf = "/root/testdata/sf0.001"
